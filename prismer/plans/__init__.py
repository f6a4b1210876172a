"""Plan building blocks: tables in shared storage that cut lineage."""
