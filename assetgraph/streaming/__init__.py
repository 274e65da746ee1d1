"""Line scans over arriving documents."""
