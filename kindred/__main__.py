import sys

from kindred.cli import main

sys.exit(main())
