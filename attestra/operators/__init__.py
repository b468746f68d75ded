"""DataFrame operators: extraction, retrieval, verification, reports, provenance, benchmark, annotation."""
