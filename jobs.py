"""Launcher for spark-submit: ``spark-submit jobs.py <command> ...``
(same commands as ``python -m wardstat``)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardstat.__main__ import main  # noqa: E402

if __name__ == "__main__":
    sys.exit(main())
