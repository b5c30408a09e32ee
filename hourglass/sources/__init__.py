"""hourglass.sources"""
