"""Tables between jobs, kept in the folder that driver and executors share."""

from tidemark.sources.shared import materialise, shared_dir, spread, table_path

__all__ = ["materialise", "shared_dir", "spread", "table_path"]
