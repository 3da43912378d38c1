import sys

from lineweave.api import main

sys.exit(main())
