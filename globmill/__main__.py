from .registry import main

main()
