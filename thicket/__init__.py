"""thicket: a Spark-first engine over hierarchical keys, triples, GraphQL documents and vectors."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
