"""Plans that compose one series from several sources: priorities, filling strategies and their execution."""
