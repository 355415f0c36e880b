"""tracelode.functions"""
