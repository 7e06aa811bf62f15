"""Size bounds and method settings.

Every bound below guards one decision: "may this be held by a single task (or
broadcast)?".  When the measured size is over the bound the operator takes its
distributed path; nothing is ever truncated to fit.
"""

from __future__ import annotations

from dataclasses import dataclass

# Values (rows x columns, array entries counted) of a lookup side that may be broadcast.
BROADCAST_VALUES = 2_000_000
# Values an exact quantile may hold in one aggregation buffer.
QUANTILE_ROWS = 500_000
# Edges that one task may finish with array code.
TASK_EDGES = 4_000_000
# Bytes of model parameters that may be broadcast to the workers.
MODEL_BYTES = 1 << 30
# Rows of a block of the similarity tiling; a tile holds block x block doubles.
BLOCK_ROWS = 2048
# Entries of a block of the similarity tiling, on average.
BLOCK_ENTRIES = 2_000_000
# Bytes of one packed block of dense vectors.
BLOCK_BYTES = 8 << 20
# Bytes of the packed blocks that a task reads of either side.
GROUP_BYTES = 256 << 20
# Copies of the column table when a dense grid is made by a join.
GRID_SLICES = 64
# File systems that pyarrow opens on the executors; their gzip files are split at members.
GZIP_SCHEMES = ("file",)
# Entries of a contingency table that one task may match.
MATCH_CELLS = 4_000_000


@dataclass(frozen=True)
class AutoencoderSettings:
    """Network and training settings shared by the two latent clustering models."""

    hidden: tuple[int, ...] = (256, 64)
    latent: int = 32
    noise: float = 2.5
    batch_size: int = 256
    pretrain_epochs: int = 300
    pretrain_rate: float = 1e-4
    epochs: int = 100
    passes: int = 10  # epochs of a shard between two averages, before targets are recomputed each epoch
    rate: float = 1e-3
    rho: float = 0.95
    alpha: float = 1.0
    gamma: float = 1.0
    must_weight: float = 1.0
    cannot_weight: float = 1.0
    update_interval: int = 1
    tol: float = 1e-3
    seed: int = 345


GMM_SETTINGS = AutoencoderSettings()
DEC_SETTINGS = AutoencoderSettings(pretrain_rate=1e-3, epochs=2000, rate=1.0)
