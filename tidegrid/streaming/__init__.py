"""tidegrid.streaming"""
