"""Readers, writers, the command line and the chunk stream."""

import gzip
import os

import pytest

from cellweave.cli import main
from cellweave.operators import annotate as A
from cellweave.sources import readers, writers
from cellweave.streaming.chunks import CHUNK_SCHEMA, annotate_stream

# 4 genes x 3 cells; the entry "4 3 9" also is the dimensions line, (1,1) is given twice
ENTRIES = ["1 1 2", "1 1 3", "2 1 1", "1 2 4", "3 2 1", "2 3 7", "4 3 9", "3 3 2", "4 1 0"]
EXPECTED = {(0, 0): 5.0, (0, 1): 1.0, (1, 0): 4.0, (1, 2): 1.0, (2, 1): 7.0, (2, 3): 9.0, (2, 2): 2.0}


def experiment_folder(path, zipped):
    def put(name, text):
        if zipped:
            with gzip.open(path / (name + ".gz"), "wt") as f:
                f.write(text)
        else:
            (path / name).write_text(text)

    put("matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n% note\n4 3 9\n" + "\n".join(ENTRIES) + "\n")
    put("barcodes.tsv", "AA-1\nBB-1\nCC-1\n")
    put("features.tsv", "".join(f"ENS{g}\tS{g}\tGene Expression\n" for g in range(4)))
    put("genes.tsv", "wrong\twrong\n")
    return str(path)


@pytest.mark.parametrize("zipped", [False, True])
def test_experiment(spark, tmp_path, zipped):
    folder = experiment_folder(tmp_path, zipped)
    for location in (folder, folder + "/"):
        exp = readers.load_experiment(spark, location)
        assert {(r.cell, r.gene): r.value for r in exp.expr.collect()} == EXPECTED
    assert [tuple(r) for r in exp.cells.orderBy("cell").collect()] == [(0, "AA-1"), (1, "BB-1"), (2, "CC-1")]
    assert [tuple(r) for r in exp.genes.orderBy("gene").collect()] == [(g, f"ENS{g}", f"S{g}") for g in range(4)]
    flipped = exp.transpose()
    assert {(r.gene, r.cell): r.value for r in flipped.expr.collect()} == EXPECTED


def test_missing_file(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("1 1 0\n")
    with pytest.raises(FileNotFoundError):
        readers.load_experiment(spark, str(tmp_path))


def test_integer_mode_refuses_fractions(spark, tmp_path):
    path = tmp_path / "matrix.mtx"
    path.write_text("2 2 1\n1 1 0.5\n")
    assert readers.read_mtx(spark, str(path)).first().value == 0.5
    with pytest.raises(Exception):
        readers.read_mtx(spark, str(path), integer=True).collect()


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("".join(f"id{n} rest of line\n" for n in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_ids(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.cell: r.id for r in rows} == {n: f"id{n}" for n in range(5000)}


def test_concatenated_gzip_members(spark, tmp_path):
    path = tmp_path / "b.tsv.gz"
    path.write_bytes(gzip.compress(b"one\ntwo\n") + gzip.compress(b"three\n"))
    assert [r.barcode for r in readers.read_barcodes(spark, str(path)).orderBy("cell").collect()] == ["one", "two", "three"]


def test_small_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    edges = readers.read_edges(spark, put("e.txt", "0 1 2.5 \n\n1 2 1\n")).collect()
    assert [tuple(r) for r in edges] == [(0, 1, 2.5), (1, 2, 1.0)]
    labels = readers.read_labels(spark, put("l.csv", "Barcode,Cluster\nc0,1\nc1,2\n"))
    assert [tuple(r) for r in labels.collect()] == [("c0", "1"), ("c1", "2")]
    assert readers.read_gene_list(spark, put("g.txt", "a\n\nb\na\n")).count() == 2
    atlas = readers.read_atlas(spark, put("a.tsv", "Gene\tGene name\tTissue\tCluster\tCell type\tRead count\nx\tS0\tskin\tc-1\tfib\t12\n"))
    assert atlas.first().asDict() == {"symbol": "S0", "tissue": "skin", "type": "fib", "cluster": "c-1", "read_count": 12.0}
    spark.createDataFrame([(0, [0.0, 2.0], 1), (1, [3.0, 0.0], 2)], "cell long, X array<double>, Y int").write.parquet(str(tmp_path / "d"))
    expr, y = readers.read_dense(spark, str(tmp_path / "d"))
    assert {(r.cell, r.gene): r.value for r in expr.collect()} == {(0, 1): 2.0, (1, 0): 3.0} and y.count() == 2


def lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            out += open(os.path.join(path, name)).read().splitlines()
    return sorted(out)


def test_writers(spark, tmp_path):
    exp = readers.load_experiment(spark, experiment_folder(tmp_path, False))
    out = lambda name: str(tmp_path / name)
    writers.write_matrix(exp.expr, exp.cells, exp.genes, out("m"), decimals=6)
    assert lines(out("m"))[0] == "0\t5.000000\t1.000000\t0.000000\t0.000000"
    writers.write_matrix(exp.expr, exp.cells, exp.genes, out("t"), decimals=1, transposed=True)
    assert lines(out("t"))[1] == "1\t1.0\t0.0\t7.0"
    pairs = spark.createDataFrame([(0, 1, 0.12345), (0, 2, -0.5), (1, 2, 1.0), (2, 3, 0.00015)], "i long, j long, r double")
    writers.write_similarity(pairs, out("s"))
    assert lines(out("s")) == ["0\t1\t0.1234", "0\t2\t-0.5", "1\t2\t1.0", "2\t3\t0.0002"]
    writers.write_graph(pairs.withColumnRenamed("r", "weight"), out("g"))
    assert lines(out("g"))[1] == "0\t2\t-0.5"
    done = exp.cells.selectExpr("cell", "barcode", "1.0D AS n_counts", "cell % 2 AS cluster", "array(0.25D, 0.75D) AS p")
    writers.write_cluster_lines(done, out("c"))
    assert lines(out("c")) == ["0\tAA-1\t0", "1\tBB-1\t1", "2\tCC-1\t0"]
    writers.write_probabilities(done, out("p"), 2)
    assert "AA-1,1.0,0,0.25,0.75" in lines(out("p"))


def test_command_line(spark, tmp_path, capsys):
    folder = experiment_folder(tmp_path, False)
    atlas = tmp_path / "atlas.tsv"
    rows = [("S0", "A", 5), ("S1", "A", 1), ("S2", "A", 0), ("S3", "A", 0), ("S0", "B", 0), ("S1", "B", 7), ("S2", "B", 2), ("S3", "B", 9)]
    atlas.write_text("Gene name\tTissue\tCell type\tCluster\tRead count\n" + "".join(f"{s}\t{t}\tk\tc\t{v}\n" for s, t, v in rows))
    main(["kmst", folder, str(tmp_path / "k"), "--filter", "variance"])
    assert lines(str(tmp_path / "k" / "clusters.csv"))[-1] == "barcode,n_counts,cluster"
    main(["kmst-union", folder, str(tmp_path / "u")])
    assert len(lines(str(tmp_path / "u" / "clusters.tsv"))) == 3
    main(["correlations", folder, str(tmp_path / "r"), "--atlas", str(atlas)])
    assert any(x.startswith("CC-1,B,k,1.0") for x in lines(str(tmp_path / "r" / "results.csv")))
    truth = tmp_path / "truth.csv"
    truth.write_text("Barcode,Cluster\nAA-1,1\nBB-1,1\nCC-1,2\n")
    main(["metrics", str(truth), str(truth)])
    assert "ACC: 1.0 NMI: 1.0 ARI: 1.0" in capsys.readouterr().out


def test_chunks_give_the_whole_result(spark, tmp_path):
    exp = readers.load_experiment(spark, experiment_folder(tmp_path, False))
    atlas = spark.createDataFrame([(f"S{g}", t, "k", "c", float((g * s) % 5)) for g in range(4) for t, s in (("A", 1), ("B", 3))],
                                  "symbol string, tissue string, type string, cluster string, read_count double")
    rows = exp.expr.join(exp.cells, "cell").select("cell", "barcode", "gene", "value")
    for cell in range(3):
        rows.filter(f"cell = {cell}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = annotate_stream(chunks, exp.genes, atlas, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(300)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("batch").distinct().count() == 3
    key = lambda r: r.barcode
    assert sorted(found.drop("batch").collect(), key=key) == sorted(A.annotate(exp, atlas).collect(), key=key)
