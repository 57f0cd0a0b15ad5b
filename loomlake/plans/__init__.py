"""loomlake.plans"""
