"""Point-in-time market research on Spark: DataFrame operators for dated evidence, panels, features and statistics."""
