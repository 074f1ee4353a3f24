"""A PySpark engine for memories of agents: retrieval, graph, lifecycle and conversation analytics as DataFrame operators."""
