from tallyloom.cli import main

main()
