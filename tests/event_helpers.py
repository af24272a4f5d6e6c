"""What tests of events share."""

from datetime import datetime, timezone

SPARSE = ("seq long, ts timestamp, host string, action string, "
          "process struct<pid:long,ppid:long,name:string,executable:string,command_line:string,start_time_ns:long,"
          "stdio_socket:boolean,parent_name:string,sha256:string>, user struct<id:long,name:string>, "
          "file struct<path:string,target:string,mode:int>, "
          "network struct<src_ip:string,dst_ip:string,dst_port:int,domain:string>, "
          "syscall struct<request:long,new_uid:long>")
BASE = datetime(2024, 5, 1, tzinfo=timezone.utc)
