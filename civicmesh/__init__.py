"""civicmesh: civic-signal analytics on Apache Spark."""
