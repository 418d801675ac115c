import sys

from pixelloom.cli import main

sys.exit(main(sys.argv[1:]))
