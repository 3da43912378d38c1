"""lineweave.operators"""
