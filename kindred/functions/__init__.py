"""kindred.functions"""
