"""netloom.streaming"""
