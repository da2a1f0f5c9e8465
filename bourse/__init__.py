"""Market analytics as Spark plans: bars, order flow, options, portfolios and risk."""
