"""Plans: inference of rules, generation plans, and translation of T-SQL."""
