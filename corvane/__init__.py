"""Corvane: analytics over software knowledge bases as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame. Time is an argument (as_of, epoch seconds),
order is an explicit column, and nothing is kept between calls.
"""
