"""DataFrame-first analytics over triples, graphs, entity matching, ontologies, embeddings and swarms."""
