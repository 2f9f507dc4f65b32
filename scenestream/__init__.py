"""scenestream: Spark analytics over object detections and the alerts they raise."""
