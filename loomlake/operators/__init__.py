"""loomlake.operators"""
