"""``python -m lumbre``."""

from lumbre.cli import main

raise SystemExit(main())
