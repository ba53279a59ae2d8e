"""panelspark.functions"""
