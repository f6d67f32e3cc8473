from cartlytics.plans.ordered import ranked_values, exact_quantiles  # noqa: F401
