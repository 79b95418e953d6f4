import sys

from astrolith.cli import main

sys.exit(main())
