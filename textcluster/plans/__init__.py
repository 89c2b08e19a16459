"""Query plans: registered queries, their SQL oracles, and the end-to-end clustering jobs."""
