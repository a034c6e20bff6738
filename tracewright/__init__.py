"""Policy-graph, trace and corpus analytics as Spark DataFrame operators."""
