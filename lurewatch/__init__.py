"""URL threat analytics as Spark jobs: features, rules, models, hybrid scores and their audits."""
