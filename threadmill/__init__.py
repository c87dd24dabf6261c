"""threadmill: a Spark-native engine for record cleaning, entity resolution and relationship scoring."""
