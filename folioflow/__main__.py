import sys

from folioflow.cli import main

sys.exit(main())
