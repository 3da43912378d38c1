"""lineweave.streaming"""
