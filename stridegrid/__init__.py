"""Motion-track and kinematics analytics on Spark DataFrames."""
