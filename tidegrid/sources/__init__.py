"""tidegrid.sources"""
