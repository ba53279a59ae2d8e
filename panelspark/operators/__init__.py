"""panelspark.operators"""
