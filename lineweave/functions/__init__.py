"""lineweave.functions"""
