"""DataFrame operators: joins, aggregates, ranking, sampling, models, metrics."""
