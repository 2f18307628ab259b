"""Jobs: event folds, market data, aggregates, positions, data quality."""
