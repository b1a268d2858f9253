"""Compositions over check results: score, issues, report and views."""
