"""tidegrid.operators"""
