"""framelake: pixel-video activity segmentation and dense time-series operators on Spark DataFrames."""
