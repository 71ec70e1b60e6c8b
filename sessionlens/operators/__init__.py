"""Product-analytics operators: DataFrame in, DataFrame out, nothing collected."""
