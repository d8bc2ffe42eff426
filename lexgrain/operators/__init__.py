"""DataFrame operators: retrieval, reranking, reports, citations, graph, evaluation, documents, metadata, DML."""
