"""panelspark.plans"""
