"""loomlake.functions"""
