"""Operators over keyed records: candidates, cascade, grouping, ranking, rules, scenes, signals, journal, cache."""
