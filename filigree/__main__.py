from filigree.cli import main

main()
