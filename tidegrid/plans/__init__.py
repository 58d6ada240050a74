"""tidegrid.plans"""
