"""DataFrame operators: filters, funnels, metrics, reports, skeletons."""
