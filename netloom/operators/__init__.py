"""netloom.operators"""
