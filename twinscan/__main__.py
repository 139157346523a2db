import sys

from twinscan.cli import main

sys.exit(main())
