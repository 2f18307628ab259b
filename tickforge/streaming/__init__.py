"""Structured Streaming: typed sources, candles, balances, tickers, topic sinks, quarantine."""
