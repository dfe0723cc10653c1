"""All registered queries: name -> (callable(spark, sf_dir), oracle SQL or None).

Every query reads the driver tables (or frames Spark derives from them) in
full; none runs on made-up input.
"""

from __future__ import annotations

import importlib

MODULES = ("views", "browser", "timeprofile", "charts", "cleaning", "upsert", "evolution")


def registry() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in MODULES:
        try:
            mod = importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name == f"{__name__}.{m}":
                continue
            raise
        for k, v in mod.reg.items.items():
            if k in out:
                raise KeyError(f"duplicate query '{k}'")
            out[k] = v
    return out
