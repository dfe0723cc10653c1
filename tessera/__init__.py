"""tessera: a PySpark-native ingest, view and chart-data engine.

Sub-packages:
  sources    file scans, encoding detection, schema inference, header mapping
  operators  cleaning, upsert/integrity, time profile, chart transforms, evolution
  functions  Column-expression helpers (dates, numbers, hashing)
  plans      view compiler, table browser, import plan, saved views
  streaming  drop-folder import with Structured Streaming
"""

from .catalog import Catalog
from .model import TableSpec, ColumnSpec, ViewConfig
from .plans.view import compile_view, view_page, view_total, preview

__all__ = ["Catalog", "TableSpec", "ColumnSpec", "ViewConfig", "compile_view",
           "view_page", "view_total", "preview"]
