"""Run analytics on Spark: labels, features, alarms, correlations, forecasts and
priced advice for keyed, ordered sensor runs."""
