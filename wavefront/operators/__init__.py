"""Operators on edge tables, adjacencies and search trees."""
