from cellweave.cli import main

main()
