"""Plan-level helpers: lineage cuts and iterative graph plans."""
