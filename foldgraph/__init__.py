"""A Spark-native engine that summarises labelled graphs by bisimulation."""
