"""Cohorts and phenotypes from linked health records, as lazy Spark DataFrames."""
