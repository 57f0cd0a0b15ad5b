"""loomlake.streaming"""
