"""sparkloom: retrieval, graph, event-log and corpus analytics as PySpark DataFrame jobs."""
