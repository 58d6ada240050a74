"""tidegrid.functions"""
