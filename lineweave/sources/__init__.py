"""lineweave.sources"""
