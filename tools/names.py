"""Print the query names of the given groups."""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from panelwatch.plans import registry  # noqa: E402

for group in sys.argv[1:]:
    before = set(registry.QUERIES)
    importlib.import_module(f"panelwatch.plans.{group}")
    print(" ".join(n for n in registry.QUERIES if n not in before))
