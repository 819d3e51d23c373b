"""Monthly panel feature engineering, rolling forecasts and evaluation on Spark."""
