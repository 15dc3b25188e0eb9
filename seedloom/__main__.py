import sys

from seedloom.cli import main

sys.exit(main())
