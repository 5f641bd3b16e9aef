import sys

from quadweave.cli import main

sys.exit(main())
