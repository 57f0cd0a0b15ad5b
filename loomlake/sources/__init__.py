"""loomlake.sources"""
