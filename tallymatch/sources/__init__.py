"""Where the six input tables come from."""

from tallymatch.sources.derived import DerivedSource
from tallymatch.sources.tables import FileSource, FrameSource, JdbcSource, Source, bounded

__all__ = ["DerivedSource", "FileSource", "FrameSource", "JdbcSource", "Source", "bounded"]
