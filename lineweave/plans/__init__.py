"""lineweave.plans"""
