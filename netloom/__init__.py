"""netloom: analytics over large spatial networks, written for Spark."""
