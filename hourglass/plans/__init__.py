"""hourglass.plans"""
