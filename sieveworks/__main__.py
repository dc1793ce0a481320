import sys

from sieveworks.cli import main

sys.exit(main())
