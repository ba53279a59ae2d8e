"""panelspark.streaming"""
