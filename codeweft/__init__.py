"""codeweft: property-graph, text and similarity analytics as Spark DataFrame plans."""
